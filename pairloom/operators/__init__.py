"""DataFrame -> DataFrame steps, parameterised by column names."""
