"""Composable DataFrame operators: intervals, sequences, motifs, vectors, scoring, glue."""
