"""Column functions: network headers, payload names, applications, text."""
