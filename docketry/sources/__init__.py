"""Rule packs, tables in, results out."""
