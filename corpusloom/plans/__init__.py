"""Plan helpers: materialisation, graph components and exact global ranks."""
