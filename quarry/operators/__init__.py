"""DataFrame operators: extraction, links, filters, crawl, reports."""
