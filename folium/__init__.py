"""Folium: bibliographic catalogue analytics written as PySpark DataFrame jobs."""
