"""quillspark: lazy, composable DataFrame operators for multi-label report datasets."""
