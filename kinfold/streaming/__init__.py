"""The linkage operators on streams."""
