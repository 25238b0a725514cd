"""Part of the point engine; see the README for the layout."""
