"""DataFrame-to-DataFrame operators: lots, bars, joins, snapshots, grounding."""
