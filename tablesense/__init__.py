"""tablesense: understand undocumented tables with plain DataFrame functions."""
