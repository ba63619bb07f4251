"""Policy files and guarded tables."""
