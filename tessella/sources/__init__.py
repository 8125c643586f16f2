"""Sessions and inputs."""
