"""Column functions: built-in expressions where they suffice, Arrow UDFs where not."""
