"""DataFrame operators: resolution of versions, ranges, paging, sequence numbers."""
