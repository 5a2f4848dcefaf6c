"""Where rows come from: message streams, day tables, databases."""
