"""Reading and writing documents, tables of cells, annotations and exports."""
