"""Writers: stage tables, gold rows and the frames of a summary workbook."""
