"""DataFrame -> DataFrame operators over long, fixed-schema tables."""
