"""Discovery methods. Each takes a (time, variable) array with names and returns records of canonical edges."""
