"""What touches programs and files: running tools, watching them, publishing their output whole."""
