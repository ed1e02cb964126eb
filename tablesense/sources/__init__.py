"""Where tables, catalogs and program texts come from, and where results go."""
