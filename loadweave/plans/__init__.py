"""Complete jobs: baselines, forecasters, live snapshot, profiling."""
