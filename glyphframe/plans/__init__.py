"""Whole flows: from page images to measurements, from measurements to clusters and neighbours, and to tests."""
