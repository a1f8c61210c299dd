"""Values that several operators share."""

#: Threshold of a positive prediction.
POSITIVE = 0.5
