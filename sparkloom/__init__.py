"""sparkloom: document preparation, retrieval and corpus analytics as Spark DataFrame work."""
