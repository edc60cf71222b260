"""DataFrame -> DataFrame operators (or Column builders) of the engine."""
