"""quillmesh: lexical, structural and matching operators as PySpark DataFrame plans."""
