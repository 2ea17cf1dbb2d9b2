"""Image kernels in numpy, run inside Arrow UDFs over tables of images."""
