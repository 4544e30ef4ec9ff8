"""Part of fathom; see README.md."""
