"""DataFrame to DataFrame transforms; none of them knows whether it runs on a batch or a stream."""
