"""sluice: Spark jobs that screen, label, split, audit and prepare large text corpora."""
