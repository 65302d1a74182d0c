"""Result tables, hardness, peeling and the benchmark runs."""
