"""DataFrame and column operators: field rules, layout, resolution, contact, catalog, report."""
