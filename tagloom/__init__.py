"""Component-usage analytics and rule rewrites over tables of source files."""
