"""Functions of names, types and sequences that expressions cannot say."""
