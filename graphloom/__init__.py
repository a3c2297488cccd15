"""A property-graph analytics engine on the DataFrame API."""
