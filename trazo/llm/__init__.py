"""Training-data operators: one module per problem, plus their queries and SQL."""
