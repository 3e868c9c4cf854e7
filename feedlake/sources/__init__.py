"""Reading the given tables and the data model's inputs.

tables (S5) · fixtures (core tables as views over the given tables) · staging (S1) ·
bronze (S2-S4, batch S8/S9 layouts, orders change events) · changefeed (stream input lines) ·
raw_posts (input rows of N1-N4)
"""
