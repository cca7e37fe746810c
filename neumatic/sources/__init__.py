"""Sources: score files, page listings, region and crop files, lexica. All read through Spark's readers."""
