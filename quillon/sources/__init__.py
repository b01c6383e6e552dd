"""Where rows come from and go to: files, dumps, the catalogue, versioned tables."""
