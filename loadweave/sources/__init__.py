"""Reading raw meter data and writing results."""
