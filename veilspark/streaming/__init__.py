"""Documents as they arrive. An addition: nothing that is compared with has a stream."""
