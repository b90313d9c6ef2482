"""Part of cloudloom."""
