"""Operators of a large-scale training-data pipeline (see README, section "Training-data operators")."""
