"""Column functions: everything here is a native expression, without Python in the tasks."""
