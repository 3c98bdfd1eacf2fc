"""Nothing streams here: the evaluated pipeline is batch only, see README."""
