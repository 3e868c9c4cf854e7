"""DataFrame -> DataFrame operators.

features (A1-A5, W2-W4, J1-J3, P7, P9-P11) · staging (P1-P5, J10) · cdc (C1-C8, W1, U1) ·
feed (J4-J8, W5, L1, L2, A6, P12) · profile (A7-A12, U2, J9) · comments (N1-N4) · vectors (E1-E6)
"""
