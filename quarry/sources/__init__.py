"""Where rows come from: seeds, pages, local files, live fetches."""
