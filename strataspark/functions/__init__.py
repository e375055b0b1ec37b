"""Part of strataspark; see README."""
