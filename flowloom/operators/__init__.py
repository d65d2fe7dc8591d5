"""Operators: decoding, inspection, flows, rules, reports, signals, chunks, search, context, evaluation."""
