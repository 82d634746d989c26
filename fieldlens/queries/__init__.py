"""All queries outside the corpus operators; importing this package registers them."""

from fieldlens.queries import aggregates, checks, clusters, designs, diagnoses, exports, joins, learning, migrations, more, ordered, planning, rasters, reconciles, scalars, shapes, streams, studies, upkeep  # noqa: F401
