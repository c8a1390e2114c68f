"""staygrid: travel-warehouse and web-page analytics as Spark DataFrame jobs."""
