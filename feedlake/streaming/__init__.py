"""Structured Streaming: envelope parsing (T1, T6, T7), keyed state logs (S12),
the speed layer (T2-T5, L3, L4), the raw lander (S8, S9, T8) and silver as a
stream (C8)."""
