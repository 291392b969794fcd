"""Plans: data-set builders, registered queries and the experiment runner."""
