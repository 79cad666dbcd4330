"""Part of pixelmill; see README.md."""
