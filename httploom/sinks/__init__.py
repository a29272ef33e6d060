"""Writers and partition layouts for items and artifacts."""
