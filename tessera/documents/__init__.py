"""Documents as rows of blocks: detection, scans, segmentation and rendering. Plain functions over one text, put over tables by `arrow.table`."""
