"""Particles-on-meshes analytics and corpus operators as Spark jobs."""
