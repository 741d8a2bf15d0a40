"""Stage tables, the runs that fill them, and the commands over them."""
