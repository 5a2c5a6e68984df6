"""Part of prismloom."""
