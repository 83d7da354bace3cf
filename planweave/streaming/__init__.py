"""Plans over tables that grow."""
