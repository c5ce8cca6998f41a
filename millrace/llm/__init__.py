"""Operators for training data: frequencies, sampling, distinctiveness, look-alikes, canonical values, token ids, leaks, subjects."""
