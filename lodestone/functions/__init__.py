"""Part of the lodestone core."""
