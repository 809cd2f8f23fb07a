"""hitlens: web-traffic analytics on PySpark.

Page hits come in as a table or stream, get decoded, checked and resolved to a
registered site, and are turned into per-site statistics over tumbling windows.
Everything is plain DataFrame / SQL work; see README.md for the layout.
"""

__version__ = "0.1.0"
