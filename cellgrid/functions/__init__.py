"""Column functions: dimension transforms, bitmap cells, roaring blobs."""
