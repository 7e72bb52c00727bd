"""gablework: building reconstruction from lidar points and footprints as Spark plans."""
