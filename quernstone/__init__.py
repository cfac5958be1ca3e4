"""Quernstone: knowledge-base retrieval and corpus preparation as Spark jobs."""
