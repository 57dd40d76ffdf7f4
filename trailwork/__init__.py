"""DataFrame operators for hunting and measuring in historical web traffic."""
