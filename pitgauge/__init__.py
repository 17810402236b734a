"""pitgauge: site-risk analytics expressed as Spark DataFrame jobs."""
