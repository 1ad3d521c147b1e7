"""Views, fixed values, lineage and text rendering."""
