"""Query planning and the multi-stage pipelines."""
