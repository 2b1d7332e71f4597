"""The batch roll-ups on unbounded inputs."""
