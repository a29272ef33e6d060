"""DataFrame -> DataFrame analyses over items."""
