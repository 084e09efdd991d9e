"""Detection and segmentation analytics over many scenes, as Spark DataFrame operators."""
