"""Knowledge analytics over document collections, written with the DataFrame API."""
