"""Operations over record tables: query, diff, context, gate, validation, trust, graph, geometry, inference."""
