"""Part of kmerloom."""
