"""Table life cycle, descriptors, metrics, graph, record linkage and spatial joins."""
