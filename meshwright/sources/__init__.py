"""Generated meshes and file formats."""
