"""See the package README for an overview of this group."""
