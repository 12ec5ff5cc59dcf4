"""segmentflow: Spark jobs for customer segmentation, retail reports and data quality."""
