"""Physical-plan helpers: cutting lineage, spreading hot keys, gapless numbering."""
