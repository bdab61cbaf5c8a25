"""See the package README for the operators of this folder."""
